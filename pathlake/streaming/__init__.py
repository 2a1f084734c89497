"""Structured Streaming over file-system events."""
