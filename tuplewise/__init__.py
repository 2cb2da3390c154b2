"""Spark-native conjunctive queries over relations of non-negative integers."""
