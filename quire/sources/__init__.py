"""Reading and writing PDF documents as tables."""
