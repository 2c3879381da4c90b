"""Structured Streaming writers."""
