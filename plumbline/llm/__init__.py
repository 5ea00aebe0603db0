"""Operators for preparing training text: near-duplicates, credentials, splitting, truncation, code and documentation
pairs, token ids, held-out text, wrong encodings. Nothing outside this package imports it."""
