"""Structured Streaming forms of the index build and of batch answering."""
