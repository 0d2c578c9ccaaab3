"""insightloom: procedural-knowledge analytics on Spark DataFrames."""
