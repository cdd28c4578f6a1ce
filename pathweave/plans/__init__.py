"""Whole jobs, test-data bindings and the query registry."""
