"""A Spark-first engine for period-indexed economic series and corpus preparation."""
