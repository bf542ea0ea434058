"""Distributed operators over scans, points and curves."""
