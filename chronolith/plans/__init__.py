"""Whole jobs: ingest, model, forecast, export."""
