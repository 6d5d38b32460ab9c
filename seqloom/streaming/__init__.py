"""Structured logs as streams."""
