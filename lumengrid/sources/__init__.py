"""Reading and writing features and results."""
