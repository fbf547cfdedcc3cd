"""Operators for preparing training corpora: filtering, deduplication, formatting, mixing and scoring."""
