"""Road-safety and street-network analytics as Spark jobs (DataFrame in, DataFrame out)."""
