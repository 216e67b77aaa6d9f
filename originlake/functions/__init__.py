"""Column functions on prefixes and dates."""
