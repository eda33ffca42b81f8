"""Operators on texts, spans and records."""
