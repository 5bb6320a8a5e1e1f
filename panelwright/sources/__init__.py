"""Scans: market panels, factor tables, series files, index bars."""
