"""Column functions: text, dates, vectors."""
