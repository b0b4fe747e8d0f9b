"""Operators of a large training-data pipeline.

Nothing outside this package imports it; ``queries.py`` registers one query per operator.
"""
