"""A Spark-native pipeline for job postings: read, extract, filter, route, deduplicate, deliver."""
