"""inkwell: document analytics on Spark."""
