"""kindred: record linkage as Spark DataFrame plans."""
