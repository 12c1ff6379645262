"""Tidewater: a PySpark-native analytics engine."""
