"""Density of records that keep arriving."""
