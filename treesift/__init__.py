"""Source-tree findings analytics on Spark."""
