"""Typed scans, streaming sources and sinks."""
