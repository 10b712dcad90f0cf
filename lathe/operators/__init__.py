"""Relational operators: aggregates, domains, windows, lists, nested data and graphs."""
