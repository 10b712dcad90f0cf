"""Fluent streams and Structured Streaming."""
