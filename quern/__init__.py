"""Declarative analytics pipelines on Spark."""
