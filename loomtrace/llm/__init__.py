"""Operators for large training corpora, their queries and the parts the corpus pipeline is made of."""
