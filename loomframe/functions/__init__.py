"""Column builders: colours, rules, text, hashing."""
