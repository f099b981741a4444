"""Column functions: text cleaning, validation, scoring and inference."""
