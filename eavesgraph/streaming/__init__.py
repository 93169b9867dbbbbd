"""Structured Streaming front of the batch operators."""
