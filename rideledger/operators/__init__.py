"""Transformations of ride and request tables, each a plain DataFrame -> DataFrame function."""
