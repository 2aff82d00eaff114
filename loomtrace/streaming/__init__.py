"""Incremental ingestion of session files."""
