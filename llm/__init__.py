"""Operators for training-data pipelines, each built by its own method; see README."""
