"""Operators for training data: deduplication, matching, grouping, tokenizing, packing, truncation."""
