"""Stages and queries over the tables."""
