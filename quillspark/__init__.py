"""Social-bias text analytics as Spark column expressions, aggregations and jobs."""
