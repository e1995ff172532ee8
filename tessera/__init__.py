"""tessera: record linkage on Spark DataFrames."""
