"""Document cleaning, vector search, soft clustering and semantic caching as Spark jobs."""
