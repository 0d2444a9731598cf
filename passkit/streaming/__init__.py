"""Structured Streaming: file streams, live tally, watermark dedup, batch dedup."""
