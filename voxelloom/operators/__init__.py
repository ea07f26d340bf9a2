"""Operators on volumes, regions and histograms."""
