"""Operators for preparing training data: ten operators, their queries and SQL."""
