"""Document ingestion, chunking and retrieval as Spark jobs."""

__version__ = "0.1.0"
