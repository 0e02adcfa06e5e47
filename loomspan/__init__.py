"""loomspan: operational analytics over Parquet tables with Spark DataFrames."""
