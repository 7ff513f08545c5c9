"""Batch and incremental jobs for legal text on Spark."""
