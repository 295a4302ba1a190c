"""Column functions: text, addresses, markup, scores."""
