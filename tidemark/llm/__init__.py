"""Operators of a training-data pipeline: cleaning, deduplication, scoring, mixing and tokenising of text."""
