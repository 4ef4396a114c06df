"""Corpus operators for building training data (one module per operator).

Nothing else in the library imports this package; ``queries`` registers one
query per operator and ``corpus_pipeline`` (repository top) chains five of them.
"""
