"""Conditional price-range distributions and related jobs on Spark."""
