"""Extraction operators built from the column functions."""
