"""Operators of a training-data pipeline: scoring, deduplication, decontamination, tokens, pages."""
