"""Relational operators over blocks, spans, cells and positions."""
