"""Driftwell: data consistency, text scans, region documents, event-state folds and config merges on Spark DataFrames."""
