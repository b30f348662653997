"""Queries composed from the operators, and the SQL that each must agree with."""
