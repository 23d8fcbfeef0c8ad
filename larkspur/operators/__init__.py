"""Operators over tables: conditions, keys and versions."""
