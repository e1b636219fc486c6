"""Queries over the project's tables, composed from the operators."""
