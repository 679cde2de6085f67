"""airloom: urban air-quality analytics as Spark DataFrame jobs."""
