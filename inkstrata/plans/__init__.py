"""Whole queries: the catalogue of registered ones, and extraction of files to Markdown."""
