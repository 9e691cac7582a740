"""A Spark-native engine for rule documents: gate, search, references, versions, operations."""
