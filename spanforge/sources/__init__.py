"""Readers, writers and content extraction."""
