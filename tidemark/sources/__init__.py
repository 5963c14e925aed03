"""Readers, writers and parsers of raw captures."""
