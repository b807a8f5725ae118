"""Readers for the landed corpus and the sinks."""
