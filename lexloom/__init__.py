"""A PySpark-native engine for building, querying and maintaining text corpora."""
