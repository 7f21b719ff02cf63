"""tessera: a PySpark-native analytics engine for text corpora and entity networks."""
