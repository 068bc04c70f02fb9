"""Builders for derived nodes: each takes parents' columns and gives a column."""
