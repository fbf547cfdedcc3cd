"""Readers of tables, logs and reports."""
