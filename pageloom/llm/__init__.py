"""Operators for large text corpora: archives, filters, sharding, tokens, models and joins."""
