"""Column functions that the query stages and the ingest share."""
