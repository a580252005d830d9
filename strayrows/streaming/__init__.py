"""Counting and scoring rows as they arrive."""
