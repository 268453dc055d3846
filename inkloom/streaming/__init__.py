"""Streaming: none.

The analysed workload has no streams, watermarks or late data, so this package holds no operator;
its windows (type-token ratio, marker density) are positional, not temporal.
"""
