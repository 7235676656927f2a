"""Scans, stored tables, fixture views and result sinks."""
