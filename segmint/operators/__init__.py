"""Relational building blocks: filters, feature blocks, statistics, modelling."""
