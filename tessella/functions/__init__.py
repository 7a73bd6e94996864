"""Expressions that Spark has under another name, and states that merge across periods."""
