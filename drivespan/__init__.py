"""Event analytics over driving logs as Spark DataFrame operators."""
