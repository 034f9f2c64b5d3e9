"""Document retrieval on Spark: discovery, chunking, embedding, hybrid search and evaluation as DataFrame plans."""

__version__ = "0.1.0"
