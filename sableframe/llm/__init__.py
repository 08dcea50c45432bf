"""Operators for preparing training text: extraction, quality, deduplication, mixing and packing.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
