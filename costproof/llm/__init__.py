"""Operators for preparing training data: de-duplication, filtering, formatting, tokens and packing."""
