"""Relations over occurrences, pixels and tiles."""
