"""Sources of the range library."""
