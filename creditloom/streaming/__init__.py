"""Structured Streaming: the event source and the live refresh of features, scores and history."""
