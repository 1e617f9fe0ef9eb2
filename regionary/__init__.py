"""Document-region analytics on Spark: operators, sources, functions, plans and streaming."""
