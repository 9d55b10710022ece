"""Readers, sinks and test-data adapters."""
