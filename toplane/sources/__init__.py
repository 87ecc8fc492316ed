"""Readers of interaction data sets."""
