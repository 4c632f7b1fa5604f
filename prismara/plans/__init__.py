"""Whole plans: support, recipes, conversion, and the registered queries."""
