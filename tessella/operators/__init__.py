"""Operators on event logs, column families, entity tables, versions, metrics and activity."""
