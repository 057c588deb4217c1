"""quire: document and text processing on Spark DataFrames."""
