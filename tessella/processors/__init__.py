"""Processors: bytes and a content type to observations."""
