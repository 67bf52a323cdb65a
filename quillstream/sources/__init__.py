"""Readers, registry ingestion and HTML helpers."""
