"""Sinks of the graph engine."""
