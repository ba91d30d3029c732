"""Governed lakehouse analytics on Spark: medallion models, profiling, data quality,
contract drift, role-scoped access and exact vector retrieval."""
