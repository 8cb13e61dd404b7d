"""Structured Streaming jobs; each agrees with its batch counterpart on the same events."""
