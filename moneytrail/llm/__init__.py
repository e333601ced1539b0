"""Operators for preparing training text: identify, clean, deduplicate, mix, pack, search, extract, format."""
