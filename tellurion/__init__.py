"""Survey analytics on Spark."""
