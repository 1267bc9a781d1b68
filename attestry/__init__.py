"""Evidence and label analytics on Spark."""
