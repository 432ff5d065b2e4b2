"""Structured Streaming forms of ingest and telemetry."""
