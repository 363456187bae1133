"""panelweave: panel data, factor research and corpus preparation as Spark jobs."""
