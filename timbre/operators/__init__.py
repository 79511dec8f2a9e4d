"""Relational operators over observations, plans, corpora, ratings and signals."""
