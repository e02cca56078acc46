"""Part of the veristrata engine."""
