"""Readers, writers and table-to-graph mappings."""
