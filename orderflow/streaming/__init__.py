"""Sinks and stateful operators for Structured Streaming."""
