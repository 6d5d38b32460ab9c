"""Column expressions: parsers, masks, tokens and phrases."""
