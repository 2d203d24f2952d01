"""Operators over findings and entities."""
