"""Relational operators: lazy ``DataFrame -> DataFrame`` functions."""
