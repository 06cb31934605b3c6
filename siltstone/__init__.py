"""Search, ranking and data-processing operators on Spark DataFrames."""
