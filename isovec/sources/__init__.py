"""Readers and writers for corpora of exact and quantised vectors."""
