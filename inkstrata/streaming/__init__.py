"""Streams: new files as blocks, and the latest version of a path after a quiet time."""
