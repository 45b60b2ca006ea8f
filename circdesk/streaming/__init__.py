"""Micro-batch use of the admission checks and batches."""
