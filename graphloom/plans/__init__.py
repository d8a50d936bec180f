"""Typed plans over the operators."""
