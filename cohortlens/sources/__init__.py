"""Inputs and outputs: CSV ingest, sinks, stand-in views over the test tables."""
