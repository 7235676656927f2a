"""Experiment settings and the jobs assembled from the operators."""
