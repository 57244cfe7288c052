"""Continuous ingestion, an extension: file rows that arrive as a stream are upserted into the catalogue batch by batch."""
