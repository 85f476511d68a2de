"""Queries over layers derived from the driver's tables, each with SQL that says the same."""
