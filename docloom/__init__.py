"""Document-relational analytics on Spark."""
