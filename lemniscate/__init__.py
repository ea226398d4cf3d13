"""Search and analysis of documents with formulas, on Spark DataFrames."""
