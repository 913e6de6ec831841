"""Reading and writing tables and listing attachment files."""
