"""Cluster usage analytics as DataFrame plans."""
