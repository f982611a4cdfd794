"""Queries over the sample tables, each with the SQL that checks it."""
