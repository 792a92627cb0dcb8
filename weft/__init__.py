"""weft: concept-graph analytics on Spark DataFrames."""
