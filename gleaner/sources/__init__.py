"""Readers of tables and captured files."""
