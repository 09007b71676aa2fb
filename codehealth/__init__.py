"""Health of many software repositories at once, as Spark jobs."""
