"""Structured Streaming variants of the hourly aggregates."""
