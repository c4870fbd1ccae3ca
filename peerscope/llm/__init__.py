"""Operators for preparing training text: deduplication, filtering, decontamination and tokens."""
