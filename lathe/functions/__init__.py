"""Scalar functions: expressions, dates, text and statistics."""
