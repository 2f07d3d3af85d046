"""Operators on vectors, sparse matrices, orderings, topologies and point clouds."""
