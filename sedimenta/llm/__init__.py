"""Operators on texts for language models."""
