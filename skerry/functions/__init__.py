"""Column functions: text, vectors and query understanding."""
