"""Queries over versioned, content-addressed data, written as DataFrame and SQL programs."""
