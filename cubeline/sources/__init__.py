"""Readers: history logs, job configurations, file listings, usage files."""
