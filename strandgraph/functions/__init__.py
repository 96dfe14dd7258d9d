"""Column functions of the graph's loaders and views. All are built-in expressions; there are no UDFs."""
