"""Survey verification and corpus preparation as Spark jobs."""
