"""Ledger operators: DataFrames in, DataFrames out."""
