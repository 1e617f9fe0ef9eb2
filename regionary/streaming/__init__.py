"""Streaming of the document-region engine."""
