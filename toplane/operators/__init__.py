"""Filters, encoders, splitters, scenarios, models and post-filters over interaction tables."""
