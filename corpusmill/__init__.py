"""Code-corpus preparation and scoring as Spark DataFrame jobs."""
