"""inkwell: document and bibliographic analytics on Spark DataFrames."""
