"""Scalar functions: numbers from values, hashes, keys, labels."""
