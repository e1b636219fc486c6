"""Incremental (Structured Streaming) maintenance of corpora and indexes."""
