"""Column-expression factories shared by the operators."""
