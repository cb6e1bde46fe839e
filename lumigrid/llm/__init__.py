"""Training-data operators: scans, filters, joins, sampling, packing and sharding of document corpora."""
