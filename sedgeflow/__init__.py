"""Event analytics on Spark: validation, deduplication, metrics, histories, publication, streams."""
