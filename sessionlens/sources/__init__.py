"""Session data in and out of Spark."""
