"""Evidence retrieval and corpus preparation as Spark DataFrame operators."""
