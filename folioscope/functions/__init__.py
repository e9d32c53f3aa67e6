"""functions of the author-page engine."""
