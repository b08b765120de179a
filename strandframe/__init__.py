"""Array-genotype analytics on Spark DataFrames."""
