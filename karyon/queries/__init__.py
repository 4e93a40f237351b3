"""Queries over the test tables, each with the same result in SQL."""
