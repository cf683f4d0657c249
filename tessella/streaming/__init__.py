"""Structured Streaming: windows, watchers, logs."""
