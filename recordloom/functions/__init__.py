"""Column functions: coercion, names, text signals, vectors and name similarity."""
