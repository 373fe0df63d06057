"""Readers for folder snapshots, sidecar texts, probe output and driver tables."""
