"""Column expressions: text, splitting, headers, paths, fixed values."""
