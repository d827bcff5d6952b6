"""Tidewatch: a Spark-first analytics engine for multilingual news monitoring."""

__version__ = "0.1.0"
