"""Column expressions without a shuffle or an action."""
