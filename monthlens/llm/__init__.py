"""Operators of a training-data pipeline: scoring, deduplication, decontamination, tokenising.

Every operator is a function of DataFrames; ``queries.py`` registers the thin
``opN_*`` queries.  Nothing outside this package imports it.
"""
