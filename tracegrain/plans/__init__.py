"""Composite plans and the helpers that materialise intermediate results."""
