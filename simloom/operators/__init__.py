"""Operators on record, edge, feature and candidate tables."""
