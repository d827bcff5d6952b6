"""Tidewatch operators."""
