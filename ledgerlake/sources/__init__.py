"""Sources: driver tables, derived fixtures, file ingest."""
