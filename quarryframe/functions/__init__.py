"""Functions of quarryframe."""
