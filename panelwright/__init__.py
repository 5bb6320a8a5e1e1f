"""Cross-sectional factor research on panel data, written for Spark."""

__version__ = "0.1.0"
