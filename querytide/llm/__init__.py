"""Operators that prepare training text: packing, tokens, filters, deduplication and scans."""
