"""Code-corpus and training-data analytics as Spark jobs."""
