"""netloom: spatial network analytics expressed as Spark DataFrames."""
