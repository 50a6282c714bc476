"""Relational operators of the curation engine."""
