"""Corpus operators for language-model training data, and their queries."""
