"""Operators for training data: pairs, sequences, clusters, duplicates, tokens, sentences.

Nothing outside this subpackage imports it.
"""
