"""Operators for preparing language-model training data; queries are in ``tessera.llm.queries``."""
