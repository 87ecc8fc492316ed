"""Decay functions, losses, samplers and metrics."""
