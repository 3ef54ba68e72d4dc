"""Declaring steps, addressing them by recipe, and scheduling their graph."""
