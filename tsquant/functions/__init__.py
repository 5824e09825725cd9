"""Column expressions and the row layout shared by the operators."""
