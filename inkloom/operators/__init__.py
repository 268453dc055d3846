"""Inkloom operators."""
