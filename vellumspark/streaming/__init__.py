"""Structured Streaming forms of the rollups and of job tracking."""
