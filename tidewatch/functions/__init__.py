"""Tidewatch functions."""
