"""Pipelines of operators, and the queries of the driver contract."""
