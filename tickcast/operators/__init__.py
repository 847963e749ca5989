"""Operators of the range library."""
