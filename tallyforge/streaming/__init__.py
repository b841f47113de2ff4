"""Structured Streaming views: progress of tasks, and coalesced saves."""
