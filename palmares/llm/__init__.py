"""Operators that prepare text corpora for training, and their queries."""
