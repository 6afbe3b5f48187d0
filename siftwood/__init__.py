"""Document ingest, indexing and retrieval as Spark jobs over tables and streams."""
