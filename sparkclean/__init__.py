"""Find, score and clear redundant records with Spark DataFrames."""
