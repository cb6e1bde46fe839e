"""File-stream ingest in micro-batches."""
