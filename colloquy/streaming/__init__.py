"""Structured Streaming versions of the rolling operators."""
