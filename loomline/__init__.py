"""Usage analytics over logs of AI coding tools, as Spark DataFrame jobs."""
