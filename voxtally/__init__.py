"""Cohort analytics over labelled 3-D volumes, expressed as Spark DataFrame jobs."""
