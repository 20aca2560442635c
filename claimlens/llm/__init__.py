"""Operators for preparing training data: thirteen of them, and the queries that run them."""
