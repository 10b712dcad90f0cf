"""From JSON and SQL queries to DataFrames, and from DataFrames to results."""
