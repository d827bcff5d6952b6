"""Tidewatch streaming."""
