"""Column helpers: text cleansing, number text, labels and severities."""
