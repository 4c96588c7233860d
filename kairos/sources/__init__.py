"""Readers, writers and the adapter views over the provided star schema."""
