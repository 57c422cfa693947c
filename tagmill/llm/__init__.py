"""Operators for preparing training text: filters, deduplication, scoring, mixing, packing."""
