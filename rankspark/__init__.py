"""Retrieval analytics and evaluation as DataFrame plans."""
