"""Training-data operators: quality, near copies, leaks, personal data, mixing, sharding.

Nothing else in the library imports this package.
"""
