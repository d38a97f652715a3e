"""Query operators."""
