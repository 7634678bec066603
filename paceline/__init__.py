"""Spatio-temporal tracking analytics as plain Spark DataFrame functions."""
