"""tidemark: snapshot-versioned tables and analytics queries on PySpark."""
