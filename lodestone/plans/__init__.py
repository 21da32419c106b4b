"""Registered queries and the SQL that each must equal."""
