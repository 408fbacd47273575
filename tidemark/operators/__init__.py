"""Relational building blocks: columns, filters, joins, aggregates, windows, reshape, grids, quality."""
