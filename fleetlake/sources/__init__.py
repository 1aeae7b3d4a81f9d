"""Text readers, streams and versioned tables."""
