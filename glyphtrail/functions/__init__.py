"""Column expressions: text, geometry, statistics, coordinates and confidence."""
