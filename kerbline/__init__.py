"""Street-preference analytics and corpus processing on Spark DataFrames."""
