"""Column functions: numbers, names, labels, text replies."""
