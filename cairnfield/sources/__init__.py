"""Scans and sinks: panels, prediction stores, scoreboards, sidecars, and the panels built from the driver's tables."""
