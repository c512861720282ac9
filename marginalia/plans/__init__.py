"""Query catalog over the driver tables."""
