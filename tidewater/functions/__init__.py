"""Tidewater's functions."""
