"""Column-level functions (pure Catalyst expressions)."""
