"""Readers and writers of volume, region and table formats."""
