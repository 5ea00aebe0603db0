"""Column expressions and per-text parsers."""
