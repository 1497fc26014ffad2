"""Knowledge-graph analytics over documents and source code, on Spark DataFrames."""
