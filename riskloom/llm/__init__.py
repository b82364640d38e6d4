"""Training-data operators: quality rules, near-duplicate search, sharding, chat formatting, WARC, mixing, tokenising.

Nothing else in the library imports this subpackage.
"""
