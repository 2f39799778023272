"""Structured Streaming versions of the log, registry and chunk operators."""
