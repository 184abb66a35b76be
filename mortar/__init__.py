"""Adaptive-mesh analytics as DataFrame transformations."""
