"""Structured Streaming counterparts of the batch rules."""
