"""Operators on SeriesFrame: alignment, windows, statistics, conversion, business days, recursion, comparison."""
