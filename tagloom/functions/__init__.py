"""Column expressions: text, JSON answers, labels, rates. No Python runs per row."""
