"""Readers, payload normalisation and the source registry."""
