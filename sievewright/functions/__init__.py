"""Column expressions: text, URLs, dates, evidence scores, language."""
