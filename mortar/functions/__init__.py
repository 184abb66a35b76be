"""Column expressions: node keys, coordinates, interpolation weights."""
