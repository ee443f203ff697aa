"""Column expressions and small building blocks shared by the operators."""
