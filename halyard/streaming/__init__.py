"""Structured Streaming: record transforms and idempotent upserts."""
