"""Corpus, record and index sources."""
