"""kinweave: news-style documents to a provenance-tracked graph of people, on Spark DataFrames."""
