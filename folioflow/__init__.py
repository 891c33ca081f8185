"""folioflow: document-collection analytics on Spark DataFrames."""
