"""Scans, cleaning and sinks (operators A1-A18)."""
