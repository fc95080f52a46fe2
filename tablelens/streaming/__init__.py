"""Streaming operators (Structured Streaming)."""
