"""Structured Streaming forms of the validation, latest-record and spend operators."""
