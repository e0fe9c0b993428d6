"""Column functions: log sequence numbers, hashes, names."""
