"""Relational, sequence and matching operators over block tables."""
