"""Curation, taxonomy, privacy and scoring operators over Spark DataFrames."""
