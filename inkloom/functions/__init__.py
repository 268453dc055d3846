"""Inkloom functions."""
