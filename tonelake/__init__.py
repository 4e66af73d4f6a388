"""Parameter presets and measured signals as Spark tables."""
