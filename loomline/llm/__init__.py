"""Operators for large-scale training data: capping, grouping, near-duplicates, text repair, packing."""
