"""Structured Streaming form of the occurrence enrichment."""
