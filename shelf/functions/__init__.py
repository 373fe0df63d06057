"""Column expressions: names, keys, formats, text clean-up."""
