"""Column expressions of flux physics."""
