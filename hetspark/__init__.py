"""Spark jobs for k-mer pair coverage analysis over sequence tables."""
