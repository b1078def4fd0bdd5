"""Population-genomics analytics as Spark DataFrame jobs."""
