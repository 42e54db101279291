"""Reading raw feeds and reading and writing tables."""
