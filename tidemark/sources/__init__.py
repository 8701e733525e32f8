"""Readers, writers and fetchers."""
