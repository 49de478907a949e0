"""Quern: a Spark-native engine for knowledge tables, graphs and retrieval."""
