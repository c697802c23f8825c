"""Streaming forms of the harvest."""
