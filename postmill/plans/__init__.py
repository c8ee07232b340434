"""Registered queries over the given tables, with the SQL they must equal."""
