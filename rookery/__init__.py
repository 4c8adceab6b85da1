"""Rookery: a PySpark-native analytics engine for corpora of board-game records."""
