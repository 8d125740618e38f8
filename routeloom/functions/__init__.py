"""Column functions: addresses, AS paths, question text, document text."""
