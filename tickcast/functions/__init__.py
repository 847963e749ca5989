"""Functions of the range library."""
