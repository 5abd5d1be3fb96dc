"""Sources of quarryframe."""
