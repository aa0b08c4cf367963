"""Corpus operators for language-model training data. Nothing else in gridloom imports this package."""
