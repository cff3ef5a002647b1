"""Corpus ingestion, retrieval, evaluation and event analytics as Spark jobs."""
