"""plumbline: documentation-contract analytics as plain PySpark DataFrame programs."""
