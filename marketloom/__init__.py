"""marketloom: market-news analytics as Spark jobs."""
