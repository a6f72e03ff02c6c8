"""Survey microdata analytics as Spark DataFrame jobs."""
