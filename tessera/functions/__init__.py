"""Columns functions: vectors, bits and text."""
