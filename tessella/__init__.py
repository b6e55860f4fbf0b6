"""tessella: a Spark-first analytics engine."""
