"""Operators for building language-model training data from a document corpus.

Every operator is a function of DataFrames; ``queries`` holds the thin contract
queries (``opN_<name>``) and ``corpus_pipeline.py`` chains five of them.
"""
