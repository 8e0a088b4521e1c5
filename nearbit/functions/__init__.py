"""Column expressions and driver-side helpers for bit strings."""
