"""Operators for training-data pipelines; each module holds one operator and its query."""
