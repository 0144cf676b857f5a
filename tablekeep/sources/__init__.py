"""Readers, writers and format adapters."""
