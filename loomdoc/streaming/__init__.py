"""Newline-delimited records as a stream."""
