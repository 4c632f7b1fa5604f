"""Streaming plans."""
