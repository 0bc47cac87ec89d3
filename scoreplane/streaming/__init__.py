"""Incremental evaluation over generation output that keeps arriving."""
