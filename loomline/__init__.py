"""loomline: a PySpark-native engine for evaluation tables, statistics, text corpora and search."""
