"""Award similarity analytics as Spark DataFrame jobs."""
