"""Whole runs: the batch job, and the registered queries over the test tables."""
