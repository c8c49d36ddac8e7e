"""Column expressions: vectors, text, lexicons, scores."""
