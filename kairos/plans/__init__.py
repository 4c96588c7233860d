"""End-to-end compositions and the registered report queries."""
