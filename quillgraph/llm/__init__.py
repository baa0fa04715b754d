"""Operators that prepare text corpora and question sets. Nothing outside this package imports it."""
