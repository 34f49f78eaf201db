"""Structured Streaming forms of the finding pipeline."""
