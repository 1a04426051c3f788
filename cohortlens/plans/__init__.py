"""Composed jobs: the registered queries, their DuckDB twins and the views they start from."""
