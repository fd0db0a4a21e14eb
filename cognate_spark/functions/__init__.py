"""Column functions: glosses, headwords, context strings, keys."""
