"""Polling sources into revisioned logs with Structured Streaming, and snapshots kept up to date."""
