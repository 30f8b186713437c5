"""Cohort text analytics on Spark: notes in, evaluated classifiers out."""
