"""A PySpark-native analytics engine for large annotated matrices and training corpora."""
