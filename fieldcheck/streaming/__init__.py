"""Continuous form of the refresh job."""
