"""Readers over landed files and tables."""
