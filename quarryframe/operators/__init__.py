"""Operators of quarryframe."""
