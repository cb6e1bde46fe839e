"""DataFrame operators: search, catalog, ingest, ground truth, evaluation, optimisation."""
