"""Operators of a training-data pipeline: token counts, deduplication, scoring,
rules, personal data, token files and source mixing.

Nothing else in the library imports this subpackage.
"""
