"""Whole jobs: coordinate lookup, county build, enrichment, refresh."""
