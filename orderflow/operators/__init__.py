"""Transforms from DataFrame to DataFrame, for batch and, where Spark allows, streams."""
