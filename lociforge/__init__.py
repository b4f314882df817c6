"""Genotype and locus quality control, and corpus preparation, as Spark jobs."""
