"""Structured Streaming into a heap."""
