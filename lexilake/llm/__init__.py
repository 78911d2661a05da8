"""Operators for training-data pipelines: filters, near-duplicates, search, packing, tokens, chats.

Nothing else in the library imports this package.
"""
