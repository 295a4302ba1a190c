"""Structured Streaming views of running audits."""
