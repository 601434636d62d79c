"""Column functions: set algebra, portable hashing, codec sizes, similarity formulas."""
