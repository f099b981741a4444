"""Relational operators that need more than one expression: components, matching, relevance."""
