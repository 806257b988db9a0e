"""Operators of a training-data pipeline: search, deduplication, token counts,
chat formatting, mixing, scoring and packing. Nothing else in the library
imports this subpackage."""
