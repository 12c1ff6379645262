"""Tidewater's operators."""
