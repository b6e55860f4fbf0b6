"""Append logs and micro-batch refresh on Structured Streaming."""
