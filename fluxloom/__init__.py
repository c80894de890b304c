"""Eddy-covariance flux post-processing as Spark jobs."""
