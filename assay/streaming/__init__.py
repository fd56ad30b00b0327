"""Checks over unbounded tables by Structured Streaming."""
