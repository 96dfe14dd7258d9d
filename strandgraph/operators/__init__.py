"""Relational operators over the graph's tables: store, graph views, search, evidence, statistics, vectors."""
