"""Structured Streaming: debounced builds, idle sessions, catch-up control, high-water marks."""
