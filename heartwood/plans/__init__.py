"""The query catalog over the driver tables."""
