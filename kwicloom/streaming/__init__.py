"""Keyword-in-context over streams."""
