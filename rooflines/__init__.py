"""A building-footprint analytics engine on Spark DataFrames."""
