"""Operators that prepare training data out of texts, vectors and dialogues."""
