"""Contact-network coverage analytics on PySpark."""
