"""Operators of a large-scale training-data pipeline (texts in, decisions and digests out)."""
