"""Query catalogue: builders and the SQL they are compared with."""
