"""Recipes: parsing, compilation, execution."""
