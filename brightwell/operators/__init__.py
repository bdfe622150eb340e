"""Relational operators outside the corpus subpackage."""
from brightwell.operators.pricing import pricing_summary

__all__ = ["pricing_summary"]
