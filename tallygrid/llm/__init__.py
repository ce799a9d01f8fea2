"""Operators for building training corpora: formatting, deduplication, filtering, search, packing and sharding.

Every operator takes and returns DataFrames. Nothing else in the library imports this package.
"""
