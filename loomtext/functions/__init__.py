"""Column functions: one document in, one value out."""
