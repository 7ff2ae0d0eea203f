"""Column expressions: names, dates, numbers."""
