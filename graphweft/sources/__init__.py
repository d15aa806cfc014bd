"""Readers: edge lists, label files, community files, raw delimited lines."""
