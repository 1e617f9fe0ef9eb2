"""Functions of the document-region engine."""
