"""Reading and writing record tables."""
