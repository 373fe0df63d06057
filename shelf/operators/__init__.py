"""Relational operators over catalog frames."""
