"""Scans, sinks and intermediate tables."""
