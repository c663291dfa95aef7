"""Operators for building training corpora: scans, filters, joins, mixing, packing, archives, search and classifiers.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query per operator.
"""
