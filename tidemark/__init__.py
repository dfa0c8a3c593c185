"""tidemark: a metrics query engine on Spark DataFrames."""
