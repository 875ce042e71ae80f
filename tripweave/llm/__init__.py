"""Operators for preparing training text: fingerprints, filters, classifiers, extraction and token files."""
