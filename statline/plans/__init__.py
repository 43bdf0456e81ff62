"""Composite jobs, the query registry and its SQL oracle."""
