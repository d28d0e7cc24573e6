"""Incremental forms of the extraction and the analysis."""
