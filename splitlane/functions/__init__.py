"""Column expressions: assignment hashing, inference, formatting."""
