"""Column functions for text, paths and JSON."""
