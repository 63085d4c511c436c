"""docweave: document analytics, retrieval and extractive answering on Spark DataFrames."""
