"""Whole runs: datasets from raw logs, and experiments over them."""
