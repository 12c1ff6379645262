"""Tidewater's streaming."""
