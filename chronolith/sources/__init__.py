"""Readers of four export formats into the observation table, and sinks."""
