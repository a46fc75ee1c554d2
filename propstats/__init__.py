"""Property-price analytics on Spark: ingest, price statistics, trends, area joins and marts."""
