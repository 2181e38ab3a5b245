"""Composed jobs and the registry of named queries over the driver tables."""
