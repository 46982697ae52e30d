"""Structured Streaming jobs and change capture."""
