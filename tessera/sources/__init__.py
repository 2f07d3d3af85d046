"""Readers, writers and generators of meshes."""
