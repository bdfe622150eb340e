"""Readers for the tables that the queries use."""
from brightwell.sources.tables import read_table

__all__ = ["read_table"]
