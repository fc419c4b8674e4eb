"""Readers, writers and the adapter for the star-schema tables."""
