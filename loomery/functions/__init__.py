"""Column functions: stable hashes and placements."""
