"""Document-archive analytics on PySpark."""
