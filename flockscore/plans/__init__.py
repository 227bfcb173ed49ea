"""Scores composed of indicators, and reports on them."""
