"""Tidewatch plans."""
