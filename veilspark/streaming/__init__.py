"""Structured Streaming forms of the batch operators; each equals its batch twin."""
