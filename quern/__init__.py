"""Corpus preparation, retrieval and answer evaluation as whole-table Spark jobs."""
