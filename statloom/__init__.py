"""Data preparation scripts on Spark: a line-oriented command language lowered to DataFrames."""
