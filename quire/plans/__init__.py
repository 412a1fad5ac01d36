"""Composed plans: whole-corpus review, version comparison and triage."""
