"""Relational, graph and comparison operators."""
