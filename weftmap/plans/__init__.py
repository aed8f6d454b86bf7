"""One module a command: compute, expected, filter, merge, view, products of domains."""
