"""Product-listing analytics and ranking as Spark DataFrame jobs."""
