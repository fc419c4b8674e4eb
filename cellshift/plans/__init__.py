"""Composed pipelines and the catalogue of registered queries."""
