"""Operators for large-scale text corpora. Nothing outside this subpackage imports it."""
