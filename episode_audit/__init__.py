"""Episode audit: quality checks, badges, digests and reports as Spark jobs."""
