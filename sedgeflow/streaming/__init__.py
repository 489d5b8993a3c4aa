"""Streams: classification, keyed deduplication with lateness, upserts."""
