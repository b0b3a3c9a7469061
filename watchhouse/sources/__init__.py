"""Readers for raw logs and tables, and the sinks."""
