"""Statistics and user functions."""
