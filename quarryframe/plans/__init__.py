"""Plans of quarryframe."""
