"""Continuous intake of offer and quote files."""
