"""Operators that prepare training data from text, pages, vectors and conversations."""
