"""Adapters from the driver tables to the domain model, and the query catalogue."""
