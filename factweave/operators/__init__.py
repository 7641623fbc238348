"""Operators on fact tables."""
