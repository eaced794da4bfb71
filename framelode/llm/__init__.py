"""Training-data operators. Nothing outside this folder imports it, but for the guarded lines of __spark_entry__.py."""
