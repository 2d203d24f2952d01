"""Readers of pages, feeds and lookup files."""
