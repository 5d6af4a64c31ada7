"""helixframe: structural-variant analytics on Spark DataFrames."""
