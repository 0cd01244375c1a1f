"""lexgrove: lexical retrieval over structured, citable text, expressed as Spark DataFrames."""
