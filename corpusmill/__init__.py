"""corpusmill: document, graph and vector retrieval analytics on Spark DataFrames."""
