"""Sources of the document-region engine."""
