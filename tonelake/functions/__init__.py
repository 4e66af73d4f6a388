"""Column functions: value translation, timing, level and filter arithmetic."""
