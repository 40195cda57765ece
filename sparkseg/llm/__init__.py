"""Training-data operators: tokenising, deduplication, filtering and scoring of text.

Nothing outside this subpackage imports it.
"""
