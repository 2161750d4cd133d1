"""A document retrieval engine on Spark: ingest, chunk, index, search, browse, keep in sync."""
