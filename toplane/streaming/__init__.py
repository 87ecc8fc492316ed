"""Structured Streaming forms of sessionization and popularity."""
