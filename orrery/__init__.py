"""Property-graph queries and corpus processing on PySpark."""
