"""Column functions: text, names, properties, parsers."""
