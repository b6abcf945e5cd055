"""Operators put together: index build, batch answering, evaluation."""
