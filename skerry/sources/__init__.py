"""Reading files and tables, and the stored index."""
