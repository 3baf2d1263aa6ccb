"""Operators of a training-data pipeline: scoring, scanning, de-duplication, packing, archives, search, BPE."""
