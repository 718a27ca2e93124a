"""Streaming: files that land in a folder are ingested as they come."""
