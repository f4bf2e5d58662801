"""linkloom: bipartite link analytics as Spark DataFrame plans."""
