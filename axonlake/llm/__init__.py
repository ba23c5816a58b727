"""Operators for language-model training data: percentiles by bisection, packing, mixing and language identification."""
