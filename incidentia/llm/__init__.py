"""Operators for preparing training text: packing, sharding, deduplication, filters, token files."""
