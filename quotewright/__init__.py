"""Quotation analytics on Spark: ingest, assign, price and export quote tables as DataFrames."""
