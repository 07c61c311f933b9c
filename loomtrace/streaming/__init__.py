"""Thin streaming variants of the batch operators."""
