"""Structured Streaming versions of the queue: windows, sessions, duplicates, and a state machine for each site."""
