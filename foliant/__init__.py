"""Foliant: a document library and its queries as Spark DataFrames."""
