"""Spark-native knowledge-graph analytics: sources, operators, plans and streams over DataFrames."""
