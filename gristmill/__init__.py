"""Evidence-backed text analytics on Spark."""
