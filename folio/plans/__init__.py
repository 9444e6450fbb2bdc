"""Queries by name, each with the SQL of the same rows."""
