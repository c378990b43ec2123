"""strataframe: versioned key-value data as Spark DataFrames."""
