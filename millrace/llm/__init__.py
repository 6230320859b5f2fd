"""Operators of a training-data pipeline: quality, duplicates, leaks, language, toxicity, tokens and shards."""
