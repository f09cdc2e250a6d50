"""Operators for large text corpora: fingerprints, sharding, joins, classifiers, decontamination, mixing, extraction."""
