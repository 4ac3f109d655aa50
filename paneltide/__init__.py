"""Panel, graph and experiment analytics as Spark DataFrame jobs."""
