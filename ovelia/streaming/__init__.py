"""Structured Streaming has no role in this engine: every operator is a batch plan (README.md)."""
