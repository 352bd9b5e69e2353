"""Operators for preparing training data: packing, encoding, filters and deduplication.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only if it
is there.
"""
