"""Inkloom plans."""
