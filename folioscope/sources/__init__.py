"""sources of the author-page engine."""
