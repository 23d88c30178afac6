"""Column expressions: geometry, colour, text and typed missingness."""
