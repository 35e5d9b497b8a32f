"""Document-privacy and corpus-preparation jobs for Apache Spark."""
