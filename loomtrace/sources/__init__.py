"""Readers: each turns one transcript format into the canonical event table."""
