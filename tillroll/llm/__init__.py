"""Operators of a training-data pipeline: token counts, packing, filtering,
deduplication, similarity joins and exact search. Nothing else in the library
imports this subpackage."""
