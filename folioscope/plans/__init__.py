"""plans of the author-page engine."""
