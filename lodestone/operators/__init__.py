"""Relational operators as plain Spark plans."""
