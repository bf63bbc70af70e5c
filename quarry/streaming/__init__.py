"""Structured Streaming endpoints."""
