"""Glyphtrail: a PySpark engine for noisy streams of positioned text blocks."""

__version__ = "0.1.0"
