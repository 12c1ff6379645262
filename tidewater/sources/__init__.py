"""Tidewater's sources."""
