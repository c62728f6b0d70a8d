"""Operators for large text corpora: dedup, search, language, toxicity, mixing, tokens, archives."""
