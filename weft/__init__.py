"""Text to knowledge graphs on Spark DataFrames."""
