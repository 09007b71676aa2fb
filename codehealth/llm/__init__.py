"""Operators of a training-data pipeline: dedup, mixing, archives, language, quality, secrets, leaks."""
