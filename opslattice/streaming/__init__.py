"""Structured Streaming forms of two batch operators."""
