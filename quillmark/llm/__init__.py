"""Operators for building training data: tokens, mixing, licences, toxicity, fingerprints, dedup, search, quality, packing."""
