"""Streaming of quarryframe."""
