"""Analytics operators for product, sales and experiment data on Spark DataFrames."""
