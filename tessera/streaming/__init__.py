"""Streaming forms of operators that reduce by key."""
