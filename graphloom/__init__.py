"""Collections of small graphs, and text corpora, as Spark jobs."""
