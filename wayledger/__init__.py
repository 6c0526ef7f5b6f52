"""Annotation-store and road-survey analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
