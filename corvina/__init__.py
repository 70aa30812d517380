"""Source-code analytics and corpus preparation on Spark DataFrames."""
