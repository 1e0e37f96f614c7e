"""Operators on DataFrames: search, scoring, pruning, compression, metrics, losses, batches."""
