"""operators of the author-page engine."""
