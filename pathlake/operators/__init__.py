"""Operators over the catalog."""
