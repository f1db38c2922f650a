"""Operators of a training-data pipeline: deduplication, decontamination, search, mixing, classifiers, archives."""
