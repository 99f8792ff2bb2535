"""Record resolution, review analytics and corpus preparation as Spark jobs."""
