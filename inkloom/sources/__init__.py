"""Inkloom sources and sinks."""
