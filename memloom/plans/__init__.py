"""Whole jobs: export, rebuild, validate, import."""
