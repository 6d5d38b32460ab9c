"""Operators on structured logs and on sequences of them."""
