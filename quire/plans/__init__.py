"""Whole pipelines: from document bytes to pages and text."""
