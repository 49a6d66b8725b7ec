"""Searches on streams."""
