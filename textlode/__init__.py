"""Code and document search analytics expressed as Spark DataFrames."""
