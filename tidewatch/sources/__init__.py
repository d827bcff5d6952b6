"""Tidewatch sources."""
