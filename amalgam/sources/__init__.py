"""Scans and shared storage."""
