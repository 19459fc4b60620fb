"""Column functions: text, names, money, identifiers, vectors."""
