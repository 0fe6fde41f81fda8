"""folioweave: document-structure analytics expressed on Spark DataFrames."""
