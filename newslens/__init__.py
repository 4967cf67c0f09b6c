"""newslens: news-intelligence analytics as Spark jobs."""
