"""Relational operators over versioned objects: DataFrames in, DataFrames out."""
