"""Column functions: analyzers, hashed vectors, similarity, projections."""
