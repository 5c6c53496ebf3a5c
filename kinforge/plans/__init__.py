"""Whole runs: blocking evaluation, matching with training and validation, and profiling."""
