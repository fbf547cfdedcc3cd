"""Compact search strings and path templates, compiled to column expressions."""
