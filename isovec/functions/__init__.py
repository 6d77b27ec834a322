"""Column builders and their SQL registration."""
