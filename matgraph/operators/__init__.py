"""Building one step: file systems, locks, publication, isolation."""
