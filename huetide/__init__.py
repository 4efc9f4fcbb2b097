"""Evidence-trend analytics expressed as Spark DataFrame and SQL jobs."""
