"""Spark-native editorial analytics over text corpora."""
