"""Structured Streaming forms: file source with AvailableNow, watermarks, keyed state, idempotent foreachBatch sinks."""
