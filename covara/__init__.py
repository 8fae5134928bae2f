"""Coverage analytics over document corpora and topic taxonomies, as PySpark DataFrame operators."""
