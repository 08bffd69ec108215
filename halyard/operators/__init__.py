"""Operators: search, collections, statistics, quantization, approximate search, operation logs, placement."""
