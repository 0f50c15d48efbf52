"""Scalar functions as Column expressions; those that have to be Python are Arrow-batched."""
