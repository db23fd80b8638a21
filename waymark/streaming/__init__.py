"""Streams of points against a static graph."""
