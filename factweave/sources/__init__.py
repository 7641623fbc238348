"""Fact tables and where they come from."""
