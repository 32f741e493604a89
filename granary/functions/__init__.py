"""Expressions and the functions that they may use."""
