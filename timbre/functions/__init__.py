"""Column functions: text, vectors, identity."""
