"""Schemas, fixed dimensions and validated query parameters: what plans are built from."""
