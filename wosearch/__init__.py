"""Metadata-aware retrieval over work orders, written as Spark DataFrame jobs."""
