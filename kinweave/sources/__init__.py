"""sources of the linkage engine."""
