"""Operators of the document-region engine."""
