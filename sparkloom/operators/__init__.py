"""Relational, vector and trie operators, each a function from DataFrame to DataFrame."""
