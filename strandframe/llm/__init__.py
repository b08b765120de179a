"""Training-data operators: ten large-scale text and vector jobs built on Spark DataFrames."""
