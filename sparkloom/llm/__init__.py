"""Training-data operators: fingerprints, PII, search, scoring, de-duplication, packing and tokenizing.

Nothing outside this package imports it.
"""
