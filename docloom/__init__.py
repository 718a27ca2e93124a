"""docloom: document ingestion and corpus analytics on Spark DataFrames."""
