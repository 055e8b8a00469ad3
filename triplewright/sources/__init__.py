"""Readers and writers of knowledge-graph tables, lookups, gold sets and results."""
