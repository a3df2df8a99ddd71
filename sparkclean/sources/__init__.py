"""Scans, snapshots and lookups."""
