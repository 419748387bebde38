"""Structured Streaming over JSON posts."""
