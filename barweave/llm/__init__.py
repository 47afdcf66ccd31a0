"""Operators for training-data pipelines: deduplication, tokens, formatting, scans, search, fixity, quality, mixing."""
