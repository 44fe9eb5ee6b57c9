"""Receipt and spend analytics as Spark DataFrame jobs."""
