"""millrace: typed record pipelines, indexed tables and analytics on Spark DataFrames."""
