"""taxograft: is-a taxonomy analytics, enrichment and record linking on Spark DataFrames."""

__version__ = "0.1.0"
