"""Road-traffic analytics as Spark DataFrame operators and streaming queries."""
