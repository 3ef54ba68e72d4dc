"""Progress: the channel that builds report through, and what listens to it."""
