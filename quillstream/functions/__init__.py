"""Column functions: text normalisation, scoring and parsing."""
