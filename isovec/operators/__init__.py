"""DataFrame operators: k-nearest neighbours, bounds fitting, quantised search with re-ranking."""
