"""Structured Streaming: audit as it happens, alerts on failures."""
