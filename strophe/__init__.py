"""strophe: Spark-first analytics over ordered series, intervals, nested plans and text."""
