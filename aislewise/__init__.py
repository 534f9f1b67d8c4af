"""aislewise: retail event analytics expressed as Spark DataFrames."""
