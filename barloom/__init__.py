"""barloom: market-bar analytics and table operators on Spark DataFrames."""
