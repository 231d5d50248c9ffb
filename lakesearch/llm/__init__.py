"""Operators for preparing training text: deduplication, filters, packing, tokens, formats."""
