"""Registered queries: what the operators do on the fixture tables, each with its SQL."""
