"""Column functions: text, vectors, requests."""
