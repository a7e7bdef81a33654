"""newsloom: news analytics, retrieval and recommendation as Spark DataFrame jobs."""
