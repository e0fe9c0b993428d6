"""Structured Streaming twins of batch operators; each has the batch operator's result when its input is drained."""
