"""Streaming of the range library."""
