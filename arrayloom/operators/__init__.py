"""Relational operators on long arrays."""
