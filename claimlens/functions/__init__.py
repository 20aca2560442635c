"""Column expressions: text, vectors, verdicts and formatting."""
