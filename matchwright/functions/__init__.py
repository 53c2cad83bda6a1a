"""Column expressions: text, JSON, vector and score functions."""
