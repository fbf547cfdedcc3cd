"""Incremental refreshes as file streams that run until nothing new is left."""
