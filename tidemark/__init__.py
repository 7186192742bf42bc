"""tidemark: retrieval, reporting and ingest operators for PySpark DataFrames."""
