"""Readers that turn bytes into rows."""
