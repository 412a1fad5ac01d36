"""Structured Streaming entry points for the review plan."""
