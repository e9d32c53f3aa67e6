"""streaming of the author-page engine."""
