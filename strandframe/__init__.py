"""A sequence-alignment analytics engine on Spark DataFrames."""
