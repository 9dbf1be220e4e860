"""Presets that bind the generic operators to a concrete set of tables."""
