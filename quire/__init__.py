"""quire: document analytics on Spark, from raw files to queryable blocks."""
