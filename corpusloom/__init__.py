"""corpusloom: retrieval and corpus indexing expressed as Spark jobs."""

__version__ = "0.1.0"
