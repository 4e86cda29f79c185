"""Structured Streaming forms of the time windows and of the event fold."""
