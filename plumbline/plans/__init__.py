"""Whole reports: several operators over one input."""
