"""Readers of exports and reference files."""
