"""Column expressions: scalars, arrays, running statistics."""
