"""Operators of a training-data pipeline: quality, toxicity, duplicates, mixing, packing, search, media, licences.

Nothing else in the library imports this subpackage.
"""
