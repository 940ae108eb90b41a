"""Operators on large text and vector corpora; nothing outside imports this package."""
