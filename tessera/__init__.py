"""A versioned object heap and its analytics on Spark DataFrames."""
