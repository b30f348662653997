"""Relational operators on panels, forecasts and scoreboards."""
