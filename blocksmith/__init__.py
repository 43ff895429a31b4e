"""blocksmith: block-oriented columnar storage and encoding analysis on PySpark."""
