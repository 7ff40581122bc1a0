"""Incremental loading as a stream of files."""
