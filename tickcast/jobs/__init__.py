"""Jobs of the range library."""
