"""Screening, profiling and modelling of large item tables on Spark."""
