"""Incremental jobs over landed files."""
