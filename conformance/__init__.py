"""Runs every operator over the given tables and states the same result in SQL."""
