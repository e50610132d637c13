"""Point-in-time market evidence as Spark DataFrames."""
