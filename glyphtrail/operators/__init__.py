"""Relational operators over blocks and tracks."""
