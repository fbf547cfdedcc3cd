"""Column functions: text clean-up, formatting and similarity."""
