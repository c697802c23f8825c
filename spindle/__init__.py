"""Dataset discovery and expression analytics on Spark."""
