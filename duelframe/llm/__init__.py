"""Operators for training-data pipelines: near duplicates, extraction, filters, tokenisation.

Nothing else in the library imports this subpackage.
"""
