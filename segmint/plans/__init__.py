"""Composed plans: domain mapping, customer-wide row, SQL view layer,
segmentation flow, registered queries and their DuckDB oracle."""
