"""Operators for preparing text corpora: sharding, dedup, filtering, packing, archives."""
