"""Operators over files, pages, blocks and the catalog; DataFrames in, DataFrames out."""
