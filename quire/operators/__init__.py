"""Relational operators over the document tables."""
