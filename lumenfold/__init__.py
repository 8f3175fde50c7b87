"""Spark jobs for measured-source catalogs, detection scoring and text corpora."""
