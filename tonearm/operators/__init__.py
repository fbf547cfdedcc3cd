"""Operators on library tables: change-logs, refreshes, matching, listings and reports."""
