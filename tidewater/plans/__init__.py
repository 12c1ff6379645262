"""Tidewater's plans."""
