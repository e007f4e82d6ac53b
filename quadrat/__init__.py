"""quadrat: survey analytics as Spark jobs."""
