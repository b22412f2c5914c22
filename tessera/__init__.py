"""Tessera: a Spark-first engine for market bars, official yields and their quality rules."""

__version__ = "0.1.0"
