"""Operators that prepare text and vectors for training, on whole tables."""
