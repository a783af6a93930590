"""Operators for preparing training data: quality, licenses, duplicates, nearest neighbours, secrets, tokens, packing."""
