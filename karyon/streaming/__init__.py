"""Operators over tables that arrive in batches."""
