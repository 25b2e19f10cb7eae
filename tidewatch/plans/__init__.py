"""Queries over the tables, each with the SQL it is checked against."""
