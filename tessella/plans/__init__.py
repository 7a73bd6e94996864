"""Declarations of entity tables."""
