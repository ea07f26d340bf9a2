"""Volumes that arrive over time."""
