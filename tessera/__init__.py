"""Mesh, sparse-system and transfer analytics as Spark DataFrame programs."""
