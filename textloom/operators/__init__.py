"""Operators over node and block tables."""
