"""Operators for training-data pipelines, each usable on any DataFrame with the named columns."""
