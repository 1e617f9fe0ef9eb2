"""Plans of the document-region engine."""
